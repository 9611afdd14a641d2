"""loomery.streaming"""
