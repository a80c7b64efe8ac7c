"""gridlark.sources"""
