"""lumenspark.operators"""
