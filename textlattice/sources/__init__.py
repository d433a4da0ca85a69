"""textlattice.sources"""
