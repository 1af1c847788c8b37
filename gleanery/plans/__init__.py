"""Runnable plans: the batch report and the registered queries."""
