"""textlattice.streaming"""
