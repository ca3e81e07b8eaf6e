"""finquarry.sources"""
