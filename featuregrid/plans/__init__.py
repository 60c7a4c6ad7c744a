"""featuregrid.plans"""
