"""Small fixtures in the procurement schema (typed in from the sample CSVs).

Fixed values: the dense demo item (36 monthly rows), the three sparse items
(5 rows each), and the last four monthly reports of their suppliers.
"""

PRICE_CSV = """nsn,item_description,date,unit_price,demand_quantity,market_index,supplier_id,contract_id,data_density_class,recommended_modeling_approach
9150-01-123-4567,Turbine Oil,2023-01-01,19.04,157,1.005,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-02-01,18.39,50,0.987,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-03-01,19.99,163,0.996,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-04-01,20.16,153,1.005,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-05-01,19.35,96,1.007,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-06-01,19.76,181,1.009,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-07-01,18.58,132,1.003,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-08-01,18.84,194,1.021,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-09-01,18.45,99,1.01,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-10-01,18.22,93,1.002,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-11-01,18.04,157,1.024,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2023-12-01,18.85,138,1.016,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-01-01,20.02,126,1.023,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-02-01,20.37,211,1.01,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-03-01,20.98,200,1.029,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-04-01,21.58,234,1.033,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-05-01,20.48,198,1.017,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-06-01,21.3,199,1.04,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-07-01,19.28,161,1.016,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-08-01,19.86,120,1.038,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-09-01,19.05,113,1.021,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-10-01,19.06,160,1.037,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-11-01,19.6,191,1.029,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2024-12-01,19.83,181,1.03,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-01-01,20.37,169,1.026,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-02-01,20.81,127,1.038,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-03-01,22.86,181,1.056,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-04-01,22.24,110,1.052,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-05-01,21.67,94,1.041,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-06-01,21.33,182,1.036,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-07-01,21.68,170,1.05,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-08-01,21.63,135,1.066,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-09-01,20.52,118,1.04,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-10-01,20.19,157,1.05,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-11-01,19.91,165,1.042,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
9150-01-123-4567,Turbine Oil,2025-12-01,21.06,199,1.062,SUP-005,CON-7781,dense_monthly,standard_arima_lstm_candidate
4820-00-111-2222,Legacy Valve,2016-01-01,437.44,4,0.961,SUP-009,CON-3004,sparse_multi_year,feature_based_forecast_or_analog_item
4820-00-111-2222,Legacy Valve,2019-05-01,462.97,1,1.028,SUP-009,CON-3004,sparse_multi_year,feature_based_forecast_or_analog_item
4820-00-111-2222,Legacy Valve,2023-02-01,672.66,3,1.086,SUP-009,CON-3004,sparse_multi_year,feature_based_forecast_or_analog_item
4820-00-111-2222,Legacy Valve,2026-04-01,678.25,5,1.221,SUP-009,CON-3004,sparse_multi_year,feature_based_forecast_or_analog_item
4820-00-111-2222,Legacy Valve,2029-08-01,775.62,2,1.284,SUP-009,CON-3004,sparse_multi_year,feature_based_forecast_or_analog_item
6110-00-333-4444,Obsolete Power Regulator,2016-01-01,1121.69,1,0.935,SUP-008,CON-3005,sparse_multi_year,feature_based_forecast_or_analog_item
6110-00-333-4444,Obsolete Power Regulator,2019-05-01,1255.19,2,1.037,SUP-008,CON-3005,sparse_multi_year,feature_based_forecast_or_analog_item
6110-00-333-4444,Obsolete Power Regulator,2023-02-01,1575.23,3,1.074,SUP-008,CON-3005,sparse_multi_year,feature_based_forecast_or_analog_item
6110-00-333-4444,Obsolete Power Regulator,2026-04-01,1836.9,5,1.192,SUP-008,CON-3005,sparse_multi_year,feature_based_forecast_or_analog_item
6110-00-333-4444,Obsolete Power Regulator,2029-08-01,2161.88,2,1.301,SUP-008,CON-3005,sparse_multi_year,feature_based_forecast_or_analog_item
1680-01-444-5555,Rare Seat Actuator,2016-01-01,2124.85,2,0.939,SUP-010,CON-3006,sparse_multi_year,feature_based_forecast_or_analog_item
1680-01-444-5555,Rare Seat Actuator,2019-05-01,2539.64,4,1.063,SUP-010,CON-3006,sparse_multi_year,feature_based_forecast_or_analog_item
1680-01-444-5555,Rare Seat Actuator,2023-02-01,2992.15,2,1.088,SUP-010,CON-3006,sparse_multi_year,feature_based_forecast_or_analog_item
1680-01-444-5555,Rare Seat Actuator,2026-04-01,3392.73,5,1.152,SUP-010,CON-3006,sparse_multi_year,feature_based_forecast_or_analog_item
1680-01-444-5555,Rare Seat Actuator,2029-08-01,4219.88,1,1.259,SUP-010,CON-3006,sparse_multi_year,feature_based_forecast_or_analog_item
"""

SHIP_CSV = """supplier_id,supplier_name,report_month,avg_lead_time_days,on_time_delivery_rate,defect_rate,primary_shipping_code,region,shipments_completed,expedite_rate,avg_freight_cost,risk_score
SUP-008,Atlas Defense Supply,2025-09-01,15.1,0.909,0.023,SC-AIR,CONUS,82,0.107,1664.2,13.4
SUP-008,Atlas Defense Supply,2025-10-01,11.1,0.948,0.01,SC-AIR,CONUS,96,0.133,1263.42,9.1
SUP-008,Atlas Defense Supply,2025-11-01,13.0,0.916,0.027,SC-AIR,CONUS,90,0.129,2152.53,14.4
SUP-008,Atlas Defense Supply,2025-12-01,16.2,0.922,0.011,SC-AIR,CONUS,46,0.144,1831.6,12.5
SUP-009,Keystone Tactical Goods,2025-09-01,21.3,0.864,0.041,SC-SEA,OCONUS,49,0.013,937.3,24.5
SUP-009,Keystone Tactical Goods,2025-10-01,22.9,0.853,0.045,SC-SEA,OCONUS,91,0.02,1059.3,28.1
SUP-009,Keystone Tactical Goods,2025-11-01,26.3,0.909,0.037,SC-SEA,OCONUS,90,0.055,1078.93,28.4
SUP-009,Keystone Tactical Goods,2025-12-01,26.3,0.832,0.058,SC-SEA,OCONUS,45,0.041,667.09,36.8
SUP-010,Mock Vendor A,2025-09-01,16.8,0.858,0.028,SC-GROUND,CONUS,35,0.068,599.89,18.2
SUP-010,Mock Vendor A,2025-10-01,17.4,0.845,0.041,SC-GROUND,CONUS,87,0.091,729.42,23.2
SUP-010,Mock Vendor A,2025-11-01,18.2,0.936,0.032,SC-GROUND,CONUS,33,0.108,501.0,17.6
SUP-010,Mock Vendor A,2025-12-01,16.0,0.912,0.032,SC-GROUND,CONUS,31,0.053,536.94,14.7
"""

# Golden values (committed metrics of the modelled application).
DENSE_MAE = 0.8152777777777794
SPARSE_MAE = 575.7241613782754
