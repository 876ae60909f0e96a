"""Container files from coded pictures."""
