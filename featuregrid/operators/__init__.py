"""featuregrid.operators"""
