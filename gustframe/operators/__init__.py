"""gustframe.operators"""
