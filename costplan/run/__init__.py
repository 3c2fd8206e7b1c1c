"""Execution, monitoring, adaptive control and evaluation."""
