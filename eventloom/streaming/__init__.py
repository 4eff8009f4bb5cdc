"""eventloom.streaming"""
