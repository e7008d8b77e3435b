"""Readers of the text formats that word lists are made from."""
