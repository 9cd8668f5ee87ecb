"""Spark jobs over large repositories of atomistic-simulation results."""
