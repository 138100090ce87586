"""pairgraph.streaming"""
