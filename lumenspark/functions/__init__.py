"""lumenspark.functions"""
