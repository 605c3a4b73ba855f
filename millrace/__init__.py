"""Spark-native building blocks for labelled sequence data sets."""
