"""Plans over trees."""
