"""corpusforge.sources"""
