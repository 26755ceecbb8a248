"""Payroll controls as functions from DataFrames to DataFrames."""
