"""loomery.sources"""
