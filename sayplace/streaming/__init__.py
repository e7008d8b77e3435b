"""The codecs on streaming DataFrames."""
