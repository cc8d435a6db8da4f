"""gustframe.functions"""
