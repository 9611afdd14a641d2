"""loomery.functions"""
