"""pairgraph.operators"""
