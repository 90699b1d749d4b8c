"""DataFrame -> DataFrame operators: cleaning, quality, dimensions, SQL models, features,
forecasting, evaluation, inventory and analytics."""
