"""quillon.functions"""
