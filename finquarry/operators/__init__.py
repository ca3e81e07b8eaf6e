"""finquarry.operators"""
