"""Spark-native engine for classifying short text lines and preparing large text corpora."""
