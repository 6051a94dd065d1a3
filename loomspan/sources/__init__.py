"""Tables from and to CSV files, caches, artifacts and a paginated product API."""
