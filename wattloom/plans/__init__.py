"""wattloom.plans"""
