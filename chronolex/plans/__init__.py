"""Registered queries: importing ``chronolex.plans.catalog`` fills the registry."""
