"""The jobs: silver cleaning, gold tables, staging, marts, dashboard queries, review themes."""
