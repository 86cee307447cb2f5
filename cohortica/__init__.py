"""Cohort analytics, voxel statistics, event folding and audits on Spark."""
