"""tokenlake.sources"""
