"""Inputs: rule tables and directory trees."""
