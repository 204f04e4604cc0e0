"""lumenspark.sources"""
