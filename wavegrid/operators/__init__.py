"""wavegrid.operators"""
