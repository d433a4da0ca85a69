"""textlattice.functions"""
