"""gustframe.plans"""
