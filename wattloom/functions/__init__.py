"""wattloom.functions"""
