"""Whole collections and the reports over what they wrote."""
