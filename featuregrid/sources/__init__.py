"""featuregrid.sources"""
