"""Fitted and aggregate operators over DataFrames."""
