"""featuregrid.streaming"""
