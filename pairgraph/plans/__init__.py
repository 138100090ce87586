"""pairgraph.plans"""
