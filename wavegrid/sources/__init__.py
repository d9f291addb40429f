"""wavegrid.sources"""
