"""wattloom.streaming"""
