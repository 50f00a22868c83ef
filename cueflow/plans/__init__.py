"""Composite jobs, and the timed-text model that the driver's tables stand for."""
