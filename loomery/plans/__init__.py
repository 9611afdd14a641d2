"""loomery.plans"""
