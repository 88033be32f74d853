"""Declarative views compiled to DataFrame plans, report rendering and templates."""
