"""finquarry.streaming"""
