"""finquarry.functions"""
