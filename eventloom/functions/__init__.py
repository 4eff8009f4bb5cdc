"""eventloom.functions"""
