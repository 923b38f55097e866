"""tokenlake.operators"""
