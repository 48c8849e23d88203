"""Bars that arrive one by one."""
