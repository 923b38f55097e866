"""tokenlake.streaming"""
