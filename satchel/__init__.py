"""Spark-native analytics for collections of optimization instances."""
