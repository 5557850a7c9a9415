"""Schemas, loads and writes of the layers: people, applications, cached answers, decisions and runs."""
