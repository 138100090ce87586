"""pairgraph.sources"""
