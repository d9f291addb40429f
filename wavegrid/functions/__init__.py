"""wavegrid.functions"""
