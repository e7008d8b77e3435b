"""DataFrame transforms: codecs, measurements and the making of word lists."""
