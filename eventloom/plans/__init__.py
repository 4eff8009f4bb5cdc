"""eventloom.plans"""
