"""wavegrid.streaming"""
