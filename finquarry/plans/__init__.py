"""finquarry.plans"""
