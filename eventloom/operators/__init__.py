"""eventloom.operators"""
