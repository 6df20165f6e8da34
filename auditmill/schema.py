"""Schemas of the inputs.  Readers never infer."""

_issuer = "struct<type:string,principalId:string,arn:string,accountId:string,userName:string>"
_attributes = "struct<creationDate:string,mfaAuthenticated:string>"
_identity = (
    "struct<type:string,principalId:string,arn:string,accountId:string,accessKeyId:string,"
    f"userName:string,sessionContext:struct<sessionIssuer:{_issuer},attributes:{_attributes}>>"
)
_request = (
    "struct<bucketName:string,bucket:string,key:string,objectKey:string,prefix:string,"
    "createBucketConfiguration:struct<locationConstraint:string>>"
)
_extra = "struct<byteTransferredIn:bigint,byteTransferredOut:bigint>"

RAW_EVENT = (
    "eventVersion string, eventID string, requestID string, eventTime string, eventSource string, "
    "eventName string, awsRegion string, eventType string, sourceIPAddress string, "
    "userAgent string, readOnly boolean, managementEvent boolean, recipientAccountId string, "
    f"errorCode string, errorMessage string, userIdentity {_identity}, "
    f"requestParameters {_request}, additionalEventData {_extra}"
)
RAW_FILE = f"Records array<struct<{RAW_EVENT}>>"

LABELS = (
    "eventID string, eventTime string, eventName string, userName string, "
    "attack_id int, attack_name string, is_attack boolean"
)
RELATION = (
    "relationship_id string, source_entity string, source_type string, relationship string, "
    "target_entity string, target_type string, confidence double"
)
TECHNIQUE = (
    "technique_id string, name string, tactics array<string>, platforms array<string>, "
    "description string, enables array<string>, aws_indicators struct<cloudtrail_events:array<string>>"
)
PATTERN = (
    "pattern_id string, name string, severity string, description string, "
    "embedding_description string, cloudtrail_event_patterns struct<eventName:array<string>>, "
    "techniques_detected array<string>, triggers_playbook array<string>, "
    "behavioral_indicators map<string,struct<threshold:double,direction:string>>, "
    "user_context struct<persona_note:string>, false_positive_sources array<string>, "
    "threshold double, time_window_minutes int, anomaly_score_threshold double"
)
PLAYBOOK = (
    "playbook_id string, name string, incident_types array<string>, "
    "techniques_addressed array<string>, triage_questions array<string>, "
    "related_playbooks array<string>, "
    "response_phases struct<containment:array<struct<action:string,cli:string>>,"
    "investigate:array<struct<step:string>>>, escalation_criteria array<string>"
)
SERVICE = (
    "service_name string, service_id string, security_sensitivity string, description string, "
    "sensitive_operations array<string>, detection_focus array<string>, related_techniques array<string>"
)
ATTACK_OBJECT = (
    "type string, name string, description string, revoked boolean, x_mitre_deprecated boolean, "
    "x_mitre_platforms array<string>, x_mitre_detection string, x_mitre_is_subtechnique boolean, "
    "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, "
    "external_references array<struct<source_name:string,external_id:string,url:string>>"
)
NODE = "id string, type string, key string, label string, props map<string,string>"
EDGE = "src string, dst string, type string, props map<string,string>"
