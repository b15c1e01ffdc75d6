"""wattloom.operators"""
