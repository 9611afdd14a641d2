"""loomery.operators"""
