"""Payroll control and reconciliation as Spark DataFrame jobs."""
