"""wattloom.sources"""
