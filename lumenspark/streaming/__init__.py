"""lumenspark.streaming"""
