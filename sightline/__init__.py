"""Analytics over camera sightings of vehicles, as operators on Spark DataFrames."""
