"""gustframe.sources"""
