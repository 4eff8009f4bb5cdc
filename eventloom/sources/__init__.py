"""eventloom.sources"""
