"""featuregrid.functions"""
