"""pairgraph.functions"""
