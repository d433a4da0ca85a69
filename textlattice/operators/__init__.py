"""textlattice.operators"""
