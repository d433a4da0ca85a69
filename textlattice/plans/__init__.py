"""textlattice.plans"""
