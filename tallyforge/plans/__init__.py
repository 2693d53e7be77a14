"""Whole runs made of operators: exploratory profile, guided intake, reports and bundles."""
