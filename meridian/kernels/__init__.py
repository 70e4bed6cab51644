"""Array kernels for what is sequential by nature; Spark calls them for many searches at once."""
