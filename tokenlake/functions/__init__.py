"""tokenlake.functions"""
