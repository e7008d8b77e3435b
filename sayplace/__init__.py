"""Spoken addresses and their analytics on Spark DataFrames."""
